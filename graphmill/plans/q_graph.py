"""Queries of joins, aggregations, windows, set operations and graph operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmill.functions import classify as C
from graphmill.functions import text as T
from graphmill.operators import binding as B
from graphmill.operators import budget as U
from graphmill.operators import graph as G
from graphmill.operators import merkle as M
from graphmill.operators import storage as S
from graphmill.operators.skew import lead_by_blocks
from graphmill.plans import fixtures as X
from graphmill.plans import match
from graphmill.session import durable, table

Q: dict = {}
SQL: dict[str, str] = {}
NE = X.ctes("g_nodes", "g_edges")
NER = X.ctes("g_nodes", "g_edges", recursive=True)
NAMES = X.ctes("g_nodes", "g_name_edges")


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql.replace(r"\S+", f"[^{T.WHITE_SPACE}]+")
        return f

    return add


# --- pattern match -----------------------------------------------------------------------

MATCH_TYPED = "MATCH (a)-[:Calls]->(b) WHERE a.kind = 'Method' AND b.name STARTS WITH 'red' RETURN a, b LIMIT 1000"


@query("graph_match_typed", f"{NE} select e.src, e.dst, e.edge_type from g_edges e join g_nodes a on a.id = e.src join g_nodes b on b.id = e.dst where e.edge_type = 'Calls' and a.kind = 'Method' and starts_with(lower(b.name), 'red') order by 1, 2, 3 limit 1000")
def graph_match_typed(s, d):
    return match.run(MATCH_TYPED, X.nodes(s, d), X.edges(s, d))


@query("graph_match_contains", f"{NE} select e.src, e.dst, e.edge_type from g_edges e join g_nodes a on a.id = e.src join g_nodes b on b.id = e.dst where e.edge_type = 'Contains' and contains(lower(a.name), 'a') and ends_with(lower(b.name), '7')")
def _(s, d):
    return match.run("MATCH (a)-[r:Contains]->(b) WHERE a.name CONTAINS 'A' AND b.name ENDS WITH '7' RETURN a, b LIMIT 10000", X.nodes(s, d), X.edges(s, d), limit=False)


@query("graph_match_nodes", f"{NE}, hit as (select e.src, e.dst from g_edges e join g_nodes a on a.id = e.src join g_nodes b on b.id = e.dst where a.kind = 'Class') select * from g_nodes where id in (select src from hit union select dst from hit)")
def _(s, d):
    return match.run("MATCH (x)-[]->(y) WHERE x.kind = 'Class' RETURN x, y LIMIT 10000", X.nodes(s, d), X.edges(s, d), limit=False)


_CUR = "(select id, arg_max(struct_pack(name := name, kind := kind, file_path := file_path), ingested_at) as s from symbols where id is not null group by id)"


@query("symbols_match_calls", f"select distinct e.src, e.dst, e.edge_type from edges e join {_CUR} a on a.id = e.src join {_CUR} b on b.id = e.dst where e.edge_type = 'Calls' and a.s.kind = 'Method'")
def _(s, d):
    from graphmill.operators.hierarchy import current_rows

    cur = current_rows(table(s, d, "symbols").select("id", "ingested_at", "name", "kind", "file_path"), "id", "ingested_at", ["name", "kind", "file_path"])
    return match.run("MATCH (a)-[:Calls]->(b) WHERE a.kind = 'Method' RETURN a, b LIMIT 10000", cur, table(s, d, "edges"), limit=False)


# --- joins -------------------------------------------------------------------------------


@query("edges_double_join", f"{NE} select e.src, e.dst, e.edge_type, a.name as src_name, b.name as dst_name from g_edges e join g_nodes a on a.id = e.src join g_nodes b on b.id = e.dst where e.edge_type = 'Imports'")
def _(s, d):
    e = B.both_ends(X.edges(s, d).filter("edge_type = 'Imports'"), X.nodes(s, d).select("id", "name"))
    return e.select("src", "dst", "edge_type", F.col("a.name").alias("src_name"), F.col("b.name").alias("dst_name"))


@query("chunk_parent_join", "select c.id, p.name, p.kind from (select distinct id, parent_symbol_id from chunks) c join (select id, arg_max(struct_pack(name := name, kind := kind), ingested_at) as s from symbols group by id) q on q.id = c.parent_symbol_id, lateral (select q.s.name as name, q.s.kind as kind) p")
def _(s, d):
    from graphmill.operators.hierarchy import current_rows

    cur = current_rows(table(s, d, "symbols").select("id", "ingested_at", "name", "kind"), "id", "ingested_at", ["name", "kind"])
    c = table(s, d, "chunks").select(F.col("id").alias("cid"), F.col("parent_symbol_id").alias("id")).distinct()
    return c.join(cur, "id").select(F.col("cid").alias("id"), "name", "kind")


@query("document_or_chunk", "with ids as (select distinct symbol_id as id from context_items), cur as (select distinct id from symbols), ch as (select id, min(parent_symbol_id) as p from chunks group by id) select i.id, coalesce(c.id, h.p) as symbol_id from ids i left join cur c on c.id = i.id left join ch h on h.id = i.id where coalesce(c.id, h.p) is not null")
def _(s, d):
    ids = table(s, d, "context_items").select(F.col("symbol_id").alias("id")).distinct()
    cur = table(s, d, "symbols").select("id").distinct().withColumn("a", F.col("id"))
    ch = table(s, d, "chunks").groupBy("id").agg(F.min("parent_symbol_id").alias("p"))
    out = ids.join(cur, "id", "left").join(ch, "id", "left")
    return out.select("id", F.coalesce("a", "p").alias("symbol_id")).filter("symbol_id is not null")


@query(
    "resolve_ranked",
    f"""{NAMES}, r as (select e.src, e.dst_name, a.file_path as sp, n.id as target, n.file_path as tp, p.name as pn from g_name_edges e join g_nodes a on a.id = e.src join g_nodes n on n.name = e.dst_name left join g_nodes p on p.id = n.parent_id),
    sc as (select *, case when sp = tp then 100.0 when regexp_replace(sp, '(^|/)[^/]*$', '') = regexp_replace(tp, '(^|/)[^/]*$', '') then 50.0 else 0.0 end as score from r)
    select src, dst_name, arg_min(target, struct_pack(s := -score, t := target)) as target, max(score)::double as score from sc group by src, dst_name""",
)
def _(s, d):
    return B.bind_ranked(X.name_edges(s, d), durable(X.nodes(s, d)))


@query(
    "resolve_locality",
    f"""{NAMES}, r as (select e.src, e.dst_name, a.file_path as sp, a.language as sl, a.parent_id as spar, n.id as target, n.file_path as tp, n.language as tl, n.parent_id as tpar from g_name_edges e join g_nodes a on a.id = e.src join g_nodes n on n.name = e.dst_name),
    sc as (select *, case when sp = tp then 1073741824 else 8 * (case when string_split(sp, '/')[1] = string_split(tp, '/')[1] then 1 else 0 end) + coalesce((sl = tl)::int, 0) + 4 * coalesce((spar = tpar)::int, 0) end as loc from r),
    b as (select src, dst_name, count(*) as n, arg_min(struct_pack(t := target, same := sp = tp), struct_pack(l := -loc, t := target)) as b from sc group by src, dst_name)
    select src, dst_name, b.t as target, case when n = 1 then 0.92 when b.same then 0.84 else 0.64 end::double as confidence, case when n = 1 then 'unique_name' when b.same then 'file_locality' else 'path_locality' end as evidence from b""",
)
def _(s, d):
    return B.bind_locality(X.name_edges(s, d), durable(X.nodes(s, d)))


@query(
    "resolve_fanout",
    f"""{NAMES}, r as (select e.src, e.dst_name, n.id as dst, case when a.file_path = n.file_path then 0 when regexp_replace(a.file_path, '(^|/)[^/]*$', '') = regexp_replace(n.file_path, '(^|/)[^/]*$', '') then 1 else 2 end as tier from g_name_edges e join g_nodes a on a.id = e.src join g_nodes n on n.name = e.dst_name),
    m as (select src, dst_name, min(tier) as tier from r group by 1, 2)
    select distinct r.src, r.dst from r join m using (src, dst_name, tier)""",
)
def _(s, d):
    return B.bind_fanout(X.name_edges(s, d), durable(X.nodes(s, d)))


@query(
    "callers_by_name",
    f"""{NAMES}, sc as (select e.src, e.dst_name, n.id as target, case when a.file_path = n.file_path then 100.0 when regexp_replace(a.file_path, '(^|/)[^/]*$', '') = regexp_replace(n.file_path, '(^|/)[^/]*$', '') then 50.0 else 0.0 end as score from g_name_edges e join g_nodes a on a.id = e.src join g_nodes n on n.name = e.dst_name),
    b as (select src, dst_name, arg_min(target, struct_pack(s := -score, t := target)) as target from sc group by 1, 2) select target as id, count(distinct src) as callers from b group by target""",
)
def _(s, d):
    return B.bind_ranked(X.name_edges(s, d), durable(X.nodes(s, d))).groupBy(F.col("target").alias("id")).agg(F.countDistinct("src").alias("callers"))


@query("callees_by_id", f"{NE} select src as id, count(distinct dst) as callees from g_edges where edge_type = 'Calls' group by src")
def _(s, d):
    return X.edges(s, d).filter("edge_type = 'Calls'").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("callees"))


@query("references_by_id", f"{NE} select dst as id, count(distinct src) as refs from g_edges where edge_type in ('Calls', 'References') group by dst")
def _(s, d):
    return X.edges(s, d).filter(F.col("edge_type").isin("Calls", "References")).groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("refs"))


@query("endpoint_semi_join", f"{NE} select src, dst, edge_type from g_edges where src in (select id from g_nodes where token_count > 20) and dst in (select id from g_nodes where token_count > 20)")
def _(s, d):
    return B.within(X.edges(s, d), X.nodes(s, d).filter("token_count > 20"))


@query("boundary_xor", f"{NE}, m as (select id from g_nodes where kind = 'Method') select src, dst, edge_type from g_edges e where (src in (select id from m)) <> (dst in (select id from m))")
def _(s, d):
    return B.crossing(X.edges(s, d), X.nodes(s, d).filter("kind = 'Method'"))


_RANGES = "select 'u' || (user_id % 10) as grp, user_id as id, min(event_id) as start, max(event_id) as end from events group by user_id"


@query(
    "range_narrowest",
    """with r as (select user_id % 10 as g, user_id as id, min(event_id) as a, max(event_id) as b from events group by user_id),
    m as (select e.event_id as pid, arg_min(r.id, struct_pack(l := r.b - r.a, i := r.id)) as owner from events e join r on r.g = e.user_id % 10 and e.event_id between r.a and r.b where e.event_type = 'purchase' group by 1)
    select e.event_id as pid, cast(coalesce(m.owner, e.user_id % 10) as varchar) as owner from events e left join m on m.pid = e.event_id where e.event_type = 'purchase'""",
)
def _(s, d):
    e = table(s, d, "events").withColumn("g", F.col("user_id") % 10)
    r = e.groupBy("g", F.col("user_id").alias("id")).agg(F.min("event_id").alias("start"), F.max("event_id").alias("end"))
    r = r.withColumn("id", F.col("id").cast("long"))
    p = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("pid"), "g", "event_id")
    return B.narrowest_range(p, r, "g", "event_id", 1 << 16).select("pid", F.col("owner").cast("string").alias("owner"))


_SPANS = "(select distinct file_path, id, start_line as a, end_line as b from symbols where file_path is not null and start_line is not null and end_line is not null and id is not null)"


@query(
    "containment_parent",
    f"""with s as (select file_path, id, min(a) as a, max(b) as b from {_SPANS} group by 1, 2)
    select c.file_path, c.id, (select u.id from s u where u.file_path = c.file_path and (u.a < c.a or (u.a = c.a and (u.b > c.b or (u.b = c.b and u.id < c.id)))) and u.b >= c.a order by u.a desc, u.b asc, u.id desc limit 1) as parent from s c""",
)
def _(s, d):
    sp = table(s, d, "symbols").dropna(subset=["file_path", "start_line", "end_line", "id"])
    sp = sp.groupBy("file_path", "id").agg(F.min("start_line").alias("start"), F.max("end_line").alias("end"))
    return B.containment_parent(sp, "file_path", 512)


@query(
    "nearest_event",
    """with p as (select event_id, user_id, ts from events where event_type = 'purchase'), v as (select event_id, user_id, ts from events where event_type = 'view')
    select p.event_id as pid, arg_min(v.event_id, struct_pack(g := abs(epoch_us(p.ts) - epoch_us(v.ts)), t := v.ts, i := v.event_id)) as near_id, min(abs(epoch_us(p.ts) - epoch_us(v.ts))) as gap_us from p join v using (user_id) group by p.event_id""",
)
def _(s, d):
    e = table(s, d, "events")
    p = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("pid"), "user_id", "ts")
    v = e.filter("event_type = 'view'").select(F.col("event_id").alias("oid"), "user_id", F.col("ts").alias("ots"))
    return B.nearest(p, v, "user_id", "ts", "ots")


_V = X.ctes("docs_v1", "docs_v2")


@query("anti_deleted", f"{_V} select doc_id from docs_v1 where doc_id not in (select doc_id from docs_v2)")
def _(s, d):
    return X.docs_v1(s, d).select("doc_id").join(X.docs_v2(s, d).select("doc_id"), "doc_id", "left_anti")


@query("hash_change_class", f"{_V} select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'new' when b.doc_id is null then 'deleted' when sha256(a.text) = sha256(b.text) then 'unchanged' else 'modified' end as change from docs_v1 a full join docs_v2 b on a.doc_id = b.doc_id")
def _(s, d):
    h = lambda df: df.select("doc_id", F.sha2("text", 256).alias("h"))
    return B.change_class(h(X.docs_v1(s, d)), h(X.docs_v2(s, d)), "doc_id", "h")


@query("multiset_align", r"""with l as (select doc_id, i, string_split(text, chr(10))[i] as line from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)),
a as (select doc_id % 7 as k, md5(line) as line, doc_id * 100000 + i as o from l where doc_id % 2 = 0), b as (select doc_id % 7 as k, md5(line) as line, doc_id * 100000 + i as o from l where doc_id % 2 = 1),
an as (select *, row_number() over (partition by k, line order by o) as n from a), bn as (select *, row_number() over (partition by k, line order by o) as n from b)
select coalesce(an.k, bn.k) as k, count(*) filter (where an.o is not null and bn.o is not null) as same, count(*) filter (where bn.o is null) as deleted, count(*) filter (where an.o is null) as inserted from an full join bn on an.k = bn.k and an.line = bn.line and an.n = bn.n group by 1""")
def _(s, d):
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    l = docs.select("doc_id", (F.col("doc_id") % 7).alias("k"), F.md5("line").alias("line"), (F.col("doc_id") * 100000 + F.col("i") + 1).alias("o"))
    m = B.align_multisets(l.filter("doc_id % 2 = 0"), l.filter("doc_id % 2 = 1"), ["k", "line"], "o")
    both = F.col("old_order").isNotNull() & F.col("new_order").isNotNull()
    return m.groupBy("k").agg(F.count_if(both).alias("same"), F.count_if(F.col("new_order").isNull()).alias("deleted"), F.count_if(F.col("old_order").isNull()).alias("inserted"))


@query("score_merge_full_outer", "with a as (select symbol_id as id, max(score) as p from context_items where score >= 0 and not isnan(score) and graph_hops = 1 group by 1), b as (select symbol_id as id, max(score) as s from context_items where score >= 0 and not isnan(score) and graph_hops = 0 group by 1) select coalesce(a.id, b.id) as id, round(case when b.s is null then 0.9 * a.p else greatest(b.s, coalesce(a.p, b.s)) end, 6) as score from a full join b on a.id = b.id")
def _(s, d):
    i = table(s, d, "context_items").filter("score >= 0 and not isnan(score)")
    a = i.filter("graph_hops = 1").groupBy(F.col("symbol_id").alias("id")).agg(F.max("score").alias("p"))
    b = i.filter("graph_hops = 0").groupBy(F.col("symbol_id").alias("id")).agg(F.max("score").alias("s"))
    return a.join(b, "id", "full_outer").select("id", F.round(F.when(F.col("s").isNull(), 0.9 * F.col("p")).otherwise(F.greatest("s", F.coalesce("p", "s"))), 6).alias("score"))


@query("overlap_theta", "with s as (select file_path, id, min(start_line) as a, max(end_line) as b from symbols where file_path is not null and start_line is not null and end_line is not null group by 1, 2) select x.file_path, count(*) as pairs from s x join s y on x.file_path = y.file_path and x.id < y.id and x.a <= y.b and y.a <= x.b group by 1")
def _(s, d):
    # overlapping pairs per file by counting: starts before an end, less ends before a start, without listing the pairs
    sp = table(s, d, "symbols").dropna(subset=["file_path", "start_line", "end_line", "id"])
    sp = sp.groupBy("file_path", "id").agg(F.min("start_line").alias("a"), F.max("end_line").alias("b"))
    ev = sp.select("file_path", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("open")), F.struct(F.col("b").alias("at"), F.lit(0).alias("open")))).alias("e"))
    per = ev.groupBy("file_path", "e.at").agg(F.sum("e.open").alias("o"), F.sum(1 - F.col("e.open")).alias("c"))
    w = W.partitionBy("file_path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("live", F.coalesce(F.sum(F.col("o") - F.col("c")).over(w), F.lit(0)))
    pairs = F.sum(F.col("o") * F.col("live") + F.col("o") * (F.col("o") - 1) / 2)
    return per.groupBy("file_path").agg(pairs.cast("long").alias("pairs")).filter("pairs > 0")


@query("parent_child_depth", """with recursive t as (select r_regionkey as id, 'r' as kind, 0 as depth, r_name as path from region union all select n.n_nationkey, 'n', t.depth + 1, concat(t.path, ' > ', n.n_name) from t join nation n on n.n_regionkey = t.id and t.kind = 'r') select kind, id, depth, path from t""")
def _(s, d):
    r = table(s, d, "region").select(F.lit("r").alias("kind"), F.col("r_regionkey").alias("id"), F.lit(0).alias("depth"), F.col("r_name").alias("path"), F.lit(None).cast("int").alias("up"))
    n = table(s, d, "nation").join(r.select(F.col("id").alias("n_regionkey"), F.col("path").alias("p")), "n_regionkey")
    return r.drop("up").unionByName(n.select(F.lit("n").alias("kind"), F.col("n_nationkey").alias("id"), F.lit(1).alias("depth"), F.concat_ws(" > ", "p", "n_name").alias("path")))


@query("ast_outline", f"with s as (select id, arg_max(struct_pack(p := parent_id, f := file_path, l := start_line, c := start_col), ingested_at) as s from symbols where id is not null group by id) select s.f as file_path, id, row_number() over (partition by s.f order by s.l, s.c, id) as pos from s")
def _(s, d):
    from graphmill.operators.hierarchy import current_rows

    cols = ["file_path", "start_line", "start_col"]
    cur = current_rows(table(s, d, "symbols").select("id", "ingested_at", *cols), "id", "ingested_at", cols)
    return cur.select("file_path", "id", F.row_number().over(W.partitionBy("file_path").orderBy(F.asc_nulls_last("start_line"), F.asc_nulls_last("start_col"), "id")).cast("long").alias("pos"))


# --- aggregations ------------------------------------------------------------------------


@query("count_by_lang", "select lang, count(*) as n from documents group by lang")
def _(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("degree_counts", f"{NE}, x as (select src as id, 1 as o, 0 as i from g_edges union all select dst, 0, 1 from g_edges) select id, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree, count(*) as degree from x group by id")
def _(s, d):
    return G.degrees(X.edges(s, d))


@query("cross_group_edges", f"{NE} select e.edge_type, count(*) filter (where a.file_path <> b.file_path) as crossing, count(*) as n from g_edges e join g_nodes a on a.id = e.src join g_nodes b on b.id = e.dst group by 1")
def _(s, d):
    e = B.both_ends(X.edges(s, d), X.nodes(s, d).select("id", "file_path"))
    return e.groupBy("edge_type").agg(F.count_if(F.col("a.file_path") != F.col("b.file_path")).alias("crossing"), F.count("*").alias("n"))


@query("dominant_lang_by_source", "with c as (select source, coalesce(lang, 'other') as lang, count(*) as n from documents group by 1, 2) select source, arg_min(lang, struct_pack(n := -n, l := lang)) as lang from c group by source")
def _(s, d):
    c = table(s, d, "documents").groupBy("source", F.coalesce("lang", F.lit("other")).alias("lang")).agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("b")).select("source", "b.lang")


@query("module_rollup", "with m as (select f.path, case when len(string_split(path, '/')) <= 1 then '(root)' else array_to_string(string_split(path, '/')[greatest(1, len(string_split(path, '/')) - 2):len(string_split(path, '/')) - 1], '/') end as module, coalesce(max(size), 0) as size from files f group by 1, 2) select module, count(*) as files, cast(sum(size) as bigint) as bytes from m group by 1 order by files desc, module limit 64")
def _(s, d):
    from graphmill.functions.paths import module_key

    m = table(s, d, "files").groupBy("path").agg(F.coalesce(F.max("size"), F.lit(0)).alias("size")).withColumn("module", module_key(F.col("path")))
    return m.groupBy("module").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("files"), "module").limit(64)


_COUNTED = ["files", "symbols", "chunks", "edges", "documents", "embeddings"]


@query("global_counts", " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in _COUNTED))
def _(s, d):
    out = None
    for t in _COUNTED:
        c = table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@query("ingestion_totals", "select repo, cast(sum(total_bytes) as bigint) as bytes, cast(sum(total_lines) as bigint) as lines, cast(sum(parsed_files) as bigint) as parsed, count(*) filter (where status = 'completed') as completed from ingestion_stats group by repo")
def _(s, d):
    return table(s, d, "ingestion_stats").groupBy("repo").agg(F.sum("total_bytes").alias("bytes"), F.sum("total_lines").alias("lines"), F.sum("parsed_files").alias("parsed"), F.count_if(F.col("status") == "completed").alias("completed"))


@query("throughput", "select run_id, round(case when duration_ms > 0 then total_lines * 1000.0 / duration_ms else 0 end, 3)::double as lines_per_s from ingestion_stats")
def _(s, d):
    return table(s, d, "ingestion_stats").select("run_id", F.round(F.when(F.col("duration_ms") > 0, F.col("total_lines") * 1000.0 / F.col("duration_ms")).otherwise(0.0), 3).alias("lines_per_s"))


@query("noisy_or", "select symbol_id, round(1 - product(1 - least(0.99, greatest(0, score))), 6) as score from context_items where score is not null and not isnan(score) group by symbol_id")
def _(s, d):
    i = table(s, d, "context_items").filter("score is not null and not isnan(score)")
    c = F.least(F.lit(0.99), F.greatest(F.lit(0.0), "score"))
    return i.groupBy("symbol_id").agg(F.round(1 - F.product(1 - c), 6).alias("score"))


@query("risk_score", f"{NE}, x as (select src as id, 0 as i from g_edges union all select dst, 1 from g_edges), g as (select id, count(*) as degree, sum(i) as fan_in from x group by id) select id, round(least(100, 18 * ln(1 + degree) + 8 * sqrt(fan_in)), 6) as risk, degree >= 20 or fan_in >= 12 as god from g")
def _(s, d):
    g = G.degrees(X.edges(s, d))
    return g.select("id", F.round(C.risk_score(F.col("degree"), F.col("in_degree")), 6).alias("risk"), ((F.col("degree") >= 20) | (F.col("in_degree") >= 12)).alias("god"))


@query("node_category", f"{NE}, x as (select src as id from g_edges union all select dst from g_edges), g as (select id, count(*) as degree from x group by id) select n.id, case when coalesce(g.degree, 0) >= 20 then 'god' when contains(lower(kind), 'component') or contains(lower(kind), 'widget') or regexp_matches(lower(file_path), '\\.(vue|tsx|dart)$') then 'ui' when contains(lower(file_path), '/api/') or contains(lower(kind), 'endpoint') or contains(lower(kind), 'handler') then 'api' else 'code' end as category from g_nodes n left join g on g.id = n.id")
def _(s, d):
    n = X.nodes(s, d).join(G.degrees(X.edges(s, d)).select("id", "degree"), "id", "left")
    return n.select("id", C.node_category(F.coalesce("degree", F.lit(0)), F.col("kind"), F.col("file_path")).alias("category"))


@query("degree_penalty", f"{NE}, x as (select src as id from g_edges union all select dst from g_edges) select id, round(1 / (1 + 0.14 * ln(1 + count(*))), 6) as penalty from x group by id")
def _(s, d):
    return G.degrees(X.edges(s, d)).select("id", F.round(C.degree_penalty(F.col("degree")), 6).alias("penalty"))


@query("token_savings", "select bundle_id, cast(sum(greatest(coalesce(tokens, 0), 0)) as bigint) as candidate, cast(greatest(sum(greatest(coalesce(tokens, 0), 0)) - sum(case when graph_hops = 0 then greatest(coalesce(tokens, 0), 0) else 0 end), 0) as bigint) as saved from context_items group by bundle_id")
def _(s, d):
    t = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))
    return table(s, d, "context_items").groupBy("bundle_id").agg(F.sum(t).alias("candidate"), F.greatest(F.sum(t) - F.sum(F.when(F.col("graph_hops") == 0, t).otherwise(0)), F.lit(0)).alias("saved"))


@query("affected_files", f"{NE} select b.id, count(distinct a.file_path) as files from g_edges e join g_nodes a on a.id = e.src join g_nodes b on b.id = e.dst where e.edge_type in ('Calls', 'References') group by b.id")
def _(s, d):
    n = X.nodes(s, d).select(F.col("id").alias("src"), "file_path")
    e = X.edges(s, d).filter(F.col("edge_type").isin("Calls", "References")).join(n, "src")
    return e.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("file_path").alias("files"))


@query("hub_names", f"{NE}, x as (select dst as id, count(*) as n from g_edges group by 1), r as (select edge_type, dst, count(*) as n from g_edges group by 1, 2), k as (select *, row_number() over (partition by edge_type order by n desc, dst) as rn from r) select edge_type, string_agg(dst, ', ' order by rn) as hubs from k where rn <= 5 group by edge_type")
def _(s, d):
    from graphmill.operators.retrieval import top_k

    r = X.edges(s, d).groupBy("edge_type", "dst").agg(F.count("*").alias("n"))
    k = top_k(r, 5, ["edge_type"], "n", "dst")
    return k.groupBy("edge_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]), ", ").alias("hubs"))


@query("argmax_chunk", "select parent_symbol_id, arg_min(id, struct_pack(t := -coalesce(token_count, 0), i := id)) as id from chunks group by parent_symbol_id")
def _(s, d):
    return table(s, d, "chunks").groupBy("parent_symbol_id").agg(F.min(F.struct((-F.coalesce("token_count", F.lit(0))).alias("t"), "id")).alias("b")).select("parent_symbol_id", "b.id")


@query("token_cost", f"with c as (select parent_symbol_id as id, sum(token_count) as t from (select distinct * from chunks) group by 1), s as (select id, max(token_count) as t from symbols where id is not null group by id) select s.id, cast(greatest(coalesce(c.t, 0), coalesce(s.t, 0), 1) as bigint) as cost from s left join c on c.id = s.id")
def _(s, d):
    sym = table(s, d, "symbols").filter("id is not null").groupBy("id").agg(F.max("token_count").alias("token_count"))
    return U.token_cost(sym, table(s, d, "chunks").distinct())


@query("max_normalised", "select item_id, round(greatest(score / greatest(abs(max(score) over (partition by bundle_id)), 1e-12), 0), 6) as rel from (select distinct item_id, bundle_id, score from context_items where score is not null and not isnan(score))")
def _(s, d):
    i = table(s, d, "context_items").filter("score is not null and not isnan(score)").select("item_id", "bundle_id", "score").distinct()
    m = i.groupBy("bundle_id").agg(F.max("score").alias("m"))
    return i.join(m, "bundle_id").select("item_id", F.round(F.greatest(F.col("score") / F.greatest(F.abs("m"), F.lit(1e-12)), F.lit(0.0)), 6).alias("rel"))


# --- windows, top-k, sets ----------------------------------------------------------------


@query("fanout_cap", f"{NE}, k as (select *, row_number() over (partition by dst order by src, edge_type) as rn from g_edges) select src, dst, edge_type from k where rn <= 8")
def _(s, d):
    w = W.partitionBy("dst").orderBy("src", "edge_type")
    return X.edges(s, d).withColumn("n", F.row_number().over(w)).filter("n <= 8").drop("n")


_TR = X.ctes("traces")


@query("trace_pairs", f"{_TR}, p as (select node as src, lead(node) over (partition by trace_id order by pos) as dst, trace_id from traces) select src, dst, count(*) as n, count(distinct trace_id) as traces from p where dst is not null group by 1, 2")
def _(s, d):
    p = lead_by_blocks(X.traces(s, d), "trace_id", "pos", ["node"])
    p = p.select(F.col("node").alias("src"), F.col("next_node").alias("dst"), "trace_id").filter("dst is not null")
    return p.groupBy("src", "dst").agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("traces"))


@query("pin_trace", f"{_TR}, k as (select *, node <> 'error' as known from traces), p as (select node as src, lead(node) over w as dst, known, lead(known) over w as dk, trace_id from k window w as (partition by trace_id order by pos)), q as (select * from p where known and dk and dst is not null) select src, dst, 'References' as edge_type, cast(max(trace_id) as varchar) as trace_id, len(list_distinct(list(trace_id))) + 1 as n_tags from q group by src, dst")
def _(s, d):
    known = s.createDataFrame([(x,) for x in ("signup", "click", "view", "purchase")], "id string")
    return G.trace_edges(X.traces(s, d), known).select("src", "dst", "edge_type", "trace_id", F.size("tags").cast("long").alias("n_tags"))


@query("running_budget", r"with l as (select doc_id, i, cast(ceil(len(regexp_extract_all(string_split(text, chr(10))[i], '\S+')) * 13 / 10.0) as bigint) as c from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)), r as (select doc_id, i, sum(c) over (partition by doc_id order by i) as run from l) select doc_id, count(*) as lines from r where run <= 64 group by doc_id")
def _(s, d):
    l = table(s, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("c", T.count_tokens(F.col("line")))
    return U.prefix_within(l, ["doc_id"], ["i"], "c", 64).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("lru_keep", "with k as (select user_id, event_id, row_number() over w as n, sum(length(props)) over (partition by user_id order by ts desc, event_id desc rows unbounded preceding) as b from events window w as (partition by user_id order by ts desc, event_id desc)) select user_id, event_id from k where n <= 20 and b <= 160")
def _(s, d):
    e = table(s, d, "events").withColumn("size", F.length("props"))
    return U.newest_within(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], "size", 20, 160).select("user_id", "event_id")


@query("replay_tail", "with k as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as seq, count(*) over (partition by user_id) as n from events) select user_id, event_id, seq from k where seq > n - 256")
def _(s, d):
    e = table(s, d, "events")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    k = e.withColumn("seq", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")).join(n, "user_id")
    return k.filter("seq > n - 256").select("user_id", "event_id", "seq")


@query("bounded_queue")
def _(s, d):
    e = table(s, d, "events").withColumn("size", F.length("props").cast("long")).withColumn("o", F.unix_micros(F.col("ts").cast("timestamp")))
    return U.bounded_queue(e, ["user_id"], "o", "size", "event_id", 50, 400)


_ITEMS = "(select item_id, any_value(bundle_id) as bundle_id, any_value(tokens) as tokens, any_value(score) as score from context_items where score is not null and not isnan(score) group by item_id)"


@query(
    "greedy_fill",
    f"""with recursive c as (select i.*, greatest(coalesce(tokens, 0), 0) as cost, b.token_budget as budget, row_number() over (partition by bundle_id order by score desc, item_id) as n from {_ITEMS} i join context_bundles b using (bundle_id)),
    w as (select bundle_id, n, item_id, case when cost <= budget then cost else 0 end as used, cost <= budget as took, budget from c where n = 1
    union all select c.bundle_id, c.n, c.item_id, w.used + case when w.used + c.cost <= c.budget then c.cost else 0 end, w.used + c.cost <= c.budget, c.budget from w join c on c.bundle_id = w.bundle_id and c.n = w.n + 1)
    select bundle_id, item_id from w where took""",
)
def _(s, d):
    i = table(s, d, "context_items").filter("score is not null and not isnan(score)").dropDuplicates(["item_id"])
    c = i.join(table(s, d, "context_bundles").select("bundle_id", "token_budget"), "bundle_id")
    return U.greedy_fill(c, ["bundle_id"], [("score", True)], "item_id", "tokens", F.col("token_budget"))


@query("hubs_top", f"{NE} select dst as id, count(*) as in_degree from g_edges group by dst order by in_degree desc, id limit 32")
def _(s, d):
    return X.edges(s, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "id").limit(32)


@query("recent_first", "select event_id, ts from events order by ts desc, event_id desc limit 100")
def _(s, d):
    return table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts")


@query("newest_sessions", "select user_id, max(ts) as last_seen from events group by user_id order by last_seen desc, user_id limit 64")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen")).orderBy(F.desc("last_seen"), "user_id").limit(64)


@query("union_adjacency", f"{NE} select src as a, dst as b from g_edges where src <> dst union select dst, src from g_edges where src <> dst")
def _(s, d):
    return G.undirected(X.edges(s, d))


@query("except_endpoints", f"{NE} select id from g_nodes except select dst from g_edges")
def _(s, d):
    return X.nodes(s, d).select("id").join(X.edges(s, d).select(F.col("dst").alias("id")), "id", "left_anti").distinct()


@query("tag_union", "select edge_id, array_to_string(list_concat(coalesce(any_value(tags), []), case when list_contains(coalesce(any_value(tags), []), 'seen') then [] else ['seen'] end), '|') as tags from edges group by edge_id")
def _(s, d):
    e = table(s, d, "edges").dropDuplicates(["edge_id"])
    return e.select("edge_id", F.array_join(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("seen"))), "|").alias("tags"))


@query("max_merge", "select symbol_id, max(score) as score from context_items where score is not null and not isnan(score) group by symbol_id")
def _(s, d):
    return table(s, d, "context_items").filter("score is not null and not isnan(score)").groupBy("symbol_id").agg(F.max("score").alias("score"))


# --- iterative ---------------------------------------------------------------------------

_PR = f"""{NE}, l as (select distinct src, dst from g_edges where src in (select id from g_nodes) and dst in (select id from g_nodes)), f as (select src, count(*) as fan from l group by src), n as (select count(*) as n from g_nodes), t as (select id, w / sum(w) over () as tele from ({{weights}})), r0 as (select id, tele as score from t)"""


def _pr_sql(weights: str, rounds: int) -> str:
    out = _PR.format(weights=weights)
    for i in range(rounds):
        out += f""", d{i} as (select coalesce(sum(score), 0) as lost from r{i} where id not in (select src from f)),
        i{i} as (select l.dst as id, sum(r.score / f.fan) as s from l join f on f.src = l.src join r{i} r on r.id = l.src group by l.dst),
        r{i + 1} as (select t.id, 0.15 * t.tele + 0.85 * (coalesce(i.s, 0) + (select lost from d{i}) * t.tele) as score from t left join i{i} i on i.id = t.id)"""
    return out + f" select id, round(score * 1000000, 4) as score from r{rounds}"


def _scores(r):
    return r.select("id", F.round(F.col("score") * 1_000_000, 4).alias("score"))


@query("pagerank_3", _pr_sql("select id, 1.0::double as w from g_nodes", 3))
def _(s, d):
    return _scores(G.pagerank(X.nodes(s, d), X.edges(s, d), iterations=3))


@query("personalized_pagerank_2", _pr_sql("select id, (case when lower(id) in ('c1', 'o7') or lower(name) in ('c1', 'o7') then 10.0 else 1.0 end) * (case when file_path = 'nation/3' or ends_with(file_path, 'nation/3') then 50.0 else 1.0 end) * (case when strlen(name) >= 8 and regexp_matches(name, '_|\\p{{Ll}}\\p{{Lu}}') and lower(name) not in ('main') then 10.0 else 1.0 end)::double as w from g_nodes".replace("{{", "{").replace("}}", "}"), 2))
def _(s, d):
    n = X.nodes(s, d)
    return _scores(G.pagerank(n, X.edges(s, d), G.personal_weight(n, ["c1", "o7"], ["nation/3"]), iterations=2))


@query("pagerank_full")
def _(s, d):
    return _scores(G.pagerank(X.nodes(s, d), X.edges(s, d)))


_ADJ = "adj as (select src as a, dst as b from g_edges where src <> dst union select dst, src from g_edges where src <> dst)"


@query("bfs_2hop", f"{NE}, {_ADJ}, h1 as (select distinct b as id from adj where a = 's1'), h2 as (select distinct adj.b as id from adj join h1 on h1.id = adj.a) select 's1' as qid, id, min(hop)::bigint as hop from (select 's1' as id, 0 as hop union all select id, 1 from h1 union all select id, 2 from h2) group by id")
def _(s, d):
    return G.expand(X.edges(s, d), s.createDataFrame([("s1", "s1")], "qid string, id string"), 2)


@query("taint_3hop", f"{NE}, {_ADJ.replace('from g_edges where', 'from g_edges where edge_type in (@) and').replace('@', chr(39) + 'Contains' + chr(39) + ', ' + chr(39) + 'Imports' + chr(39))}, h0 as (select 'r1' as id, 'user-input' as label), h1 as (select distinct b as id, label from adj join h0 on h0.id = a), h2 as (select distinct b as id, label from adj join h1 on h1.id = a), h3 as (select distinct b as id, label from adj join h2 on h2.id = a) select id, label, min(hop)::bigint as hop from (select *, 0 as hop from h0 union all select *, 1 from h1 union all select *, 2 from h2 union all select *, 3 from h3) group by 1, 2")
def _(s, d):
    return G.propagate_labels(X.edges(s, d), s.createDataFrame([("r1", "user-input")], "id string, label string"), 3, ["Contains", "Imports"])


@query("pin_taint", f"{NE}, {_ADJ.replace('from g_edges where', 'from g_edges where edge_type = @ and').replace('@', chr(39) + 'Contains' + chr(39))}, h as (select 'r1' as id union select 'r2'), h1 as (select distinct b as id from adj join h on h.id = a union select id from h) select src, dst, edge_type, 'taint:x' as tags from g_edges where edge_type = 'Contains' and src in (select id from h1) and dst in (select id from h1)")
def _(s, d):
    e = X.edges(s, d).filter("edge_type = 'Contains'")
    lab = G.propagate_labels(e, s.createDataFrame([("r1", "x"), ("r2", "x")], "id string, label string"), 1)
    return G.carried_edges(e, lab).select("src", "dst", "edge_type", F.array_join("tags", "|").alias("tags"))


@query("components", f"{NER}, e as (select src, dst from g_edges where edge_type = 'Contains'), adj as (select src as a, dst as b from e union select dst, src from e), w as (select a as id, a as node from adj union select w.id, adj.b from w join adj on adj.a = w.node where w.id like 'r%' or w.id like 'n%' or w.id like 's%') select id, min(node) as component from w where id like 'r%' or id like 'n%' or id like 's%' group by id")
def _(s, d):
    c = G.components(X.edges(s, d).filter("edge_type = 'Contains'"))
    return c.filter(~F.col("id").startswith("c")).withColumn("component", F.col("component"))


@query("components_full")
def _(s, d):
    """Every node with an edge of any kind; `components` is the part of it that recursive SQL can check."""
    return G.components(X.edges(s, d))


@query("ranked_expansion_1hop", f"""{NE}, deg as (select id, count(*) as degree from (select src as id from g_edges union all select dst from g_edges) group by id),
w as (select src as a, dst as b, edge_type, case edge_type when 'Calls' then 0.96 when 'Imports' then 0.86 when 'References' then 0.78 when 'Contains' then 0.74 end as w from g_edges union all select dst, src, edge_type, case edge_type when 'Calls' then 0.96 when 'Imports' then 0.86 when 'References' then 0.78 when 'Contains' then 0.74 end from g_edges),
k as (select *, row_number() over (partition by a order by w desc, b, edge_type) as n from w where a <> b)
select k.a as qid, b as id, round(max(0.72 * w / (1 + 0.14 * ln(1 + degree))), 6) as score, 1::bigint as hop from k join deg on deg.id = k.b where n <= 96 and k.a in ('s1', 'n3', 'p5') group by 1, 2""")
def _(s, d):
    roots = s.createDataFrame([(x, x) for x in ("s1", "n3", "p5")], "qid string, id string")
    return G.ranked_expansion(X.edges(s, d), roots, 1).withColumn("score", F.round("score", 6))


@query("predict_context_1hop", f"""{NE}, pw as (select src, dst, case edge_type when 'Calls' then 1.0 when 'Imports' then 0.7 when 'References' then 0.6 when 'Contains' then 0.5 end as w from g_edges),
w as (select src as a, dst as b, w from pw union select dst, src, w * 0.85 from pw), k as (select *, row_number() over (partition by a order by w desc, b) as n from w where a <> b),
seeds as (select 'c3' as id union all select 'n2'), mates as (select s.id as qid, m.id, 0.15 as c, 1 as hop from seeds s join g_nodes a on a.id = s.id join g_nodes m on m.file_path = a.file_path and m.id <> s.id),
g as (select * from mates union all select s.id, b, least(0.99, w * 0.7), 1 from seeds s join k on k.a = s.id where n <= 256)
select qid, id, round(1 - product(1 - c), 6) as score, min(hop)::bigint as hop from g where id <> qid group by 1, 2""")
def _(s, d):
    seeds = s.createDataFrame([("c3", "c3"), ("n2", "n2")], "qid string, id string")
    return G.predict_context(X.nodes(s, d), X.edges(s, d), seeds, hops=1).withColumn("score", F.round("score", 6))


@query("predict_context")
def _(s, d):
    seeds = s.createDataFrame([("q", "c3"), ("q", "o7")], "qid string, id string")
    return G.predict_context(X.nodes(s, d), X.edges(s, d), seeds).withColumn("score", F.round("score", 6))


@query("prune_context")
def _(s, d):
    n, e = X.nodes(s, d), X.edges(s, d)
    seeds = s.createDataFrame([("q", "c3"), ("q", "o7")], "qid string, id string")
    return U.prune_context(n, e, seeds, n.select("id", F.col("token_count").alias("cost")), 2_048)[0]


@query("graph_snapshot_nodes", f"{NE}, g as (select id, count(*) as degree from (select src as id from g_edges union all select dst from g_edges) group by id) select n.id, g.degree from g_nodes n join g using (id) order by degree desc, id limit 1000")
def _(s, d):
    return X.nodes(s, d).select("id").join(G.degrees(X.edges(s, d)).select("id", "degree"), "id").orderBy(F.desc("degree"), "id").limit(1000)


@query("graph_snapshot")
def _(s, d):
    return G.connected_first(X.nodes(s, d), X.edges(s, d), 1_000)[0].select("id", "kind", "degree")


@query("impact_report", f"""{NE}, x as (select src as id, 1 as o, 0 as i from g_edges union all select dst, 0, 1 from g_edges), g as (select id, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree from x group by id),
c as (select dst as id, count(distinct src) filter (where edge_type = 'Calls') as callers, count(distinct src) as refs from g_edges where edge_type in ('Calls', 'References') group by dst)
select g.id, g.in_degree, g.out_degree, coalesce(c.callers, 0) as callers, coalesce(c.refs, 0) as refs, round(least(100, 18 * ln(1 + in_degree + out_degree) + 8 * sqrt(in_degree)), 6) as risk from g left join c using (id)""")
def _(s, d):
    e = X.edges(s, d)
    c = e.filter(F.col("edge_type").isin("Calls", "References")).groupBy(F.col("dst").alias("id")).agg(F.countDistinct(F.when(F.col("edge_type") == "Calls", F.col("src"))).alias("callers"), F.countDistinct("src").alias("refs"))
    g = G.degrees(e).join(c, "id", "left")
    return g.select("id", "in_degree", "out_degree", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("refs", F.lit(0)).alias("refs"), F.round(C.risk_score(F.col("degree"), F.col("in_degree")), 6).alias("risk"))


@query("architecture_layers", "with p as (select distinct path from files), l as (select path, case " + " ".join("when " + " or ".join(f"contains(path, '{m}')" for m in ms) + f" then '{k}'" for k, ms in C.LAYERS) + " else 'core' end as layer from p) select layer, count(*) as files from l group by layer")
def _(s, d):
    return table(s, d, "files").select("path").distinct().groupBy(C.layer_of(F.col("path")).alias("layer")).agg(F.count("*").alias("files"))


@query("community_report", f"{NE}, e as (select * from g_edges where edge_type = 'Contains'), m as (select id, file_path, kind, case when id like 'r%' then id when id like 'n%' then parent_id else (select parent_id from g_nodes p where p.id = n.parent_id) end as component from g_nodes n where id like 'r%' or id like 'n%' or id like 'c%' or id like 's%'), c as (select component, count(*) as members, count(distinct file_path) as files from m group by 1) select members, files, count(*) as n from c group by 1, 2")
def _(s, d):
    comp = G.components(X.edges(s, d).filter("edge_type = 'Contains'"))
    m = comp.join(X.nodes(s, d).select("id", "file_path", "kind"), "id")
    c = m.groupBy("component").agg(F.count("*").alias("members"), F.countDistinct("file_path").alias("files"))
    return c.groupBy("members", "files").agg(F.count("*").alias("n"))


# --- snapshots, storage ------------------------------------------------------------------


def _tree(df):
    return M.merkle_build(df.select(F.concat_ws("/", F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("e"), (F.col("doc_id") % 31).cast("string")), F.concat("doc_id", F.lit(".txt"))).alias("path"), F.sha2("text", 256).alias("hash")))


def _tree_sql(src: str, p: str) -> str:
    line = "concat_ws('|', {0}, kind, hash)"

    def level(name: str, of: str, up: str, base: str) -> str:
        return f"""{name}b as (select {up} as path, substr(sha256({base}), 1, 3) as part, sha256(string_agg({line.format(base)}, chr(10) order by {line.format(base)})) as h from {of} group by 1, 2),
        {name} as (select path, 'dir' as kind, sha256(string_agg(concat_ws('|', part, h), chr(10) order by concat_ws('|', part, h))) as hash from {name}b group by 1)"""

    return f"""{p}f as (select concat('d', doc_id % 7, '/e', doc_id % 31, '/', doc_id, '.txt') as path, 'file' as kind, sha256(text) as hash from {src}),
    {level(p + '2', p + 'f', "regexp_replace(path, '/[^/]*$', '')", "string_split(path, '/')[-1]")}, {level(p + '1', p + '2', "regexp_replace(path, '/[^/]*$', '')", "string_split(path, '/')[-1]")}, {level(p + '0', p + '1', "''", "path")}"""


@query("merkle_build", f"{X.ctes('docs_v1')}, {_tree_sql('docs_v1', 'a')} select path, kind, 3::bigint as depth, hash from af union all select path, kind, 2, hash from a2 union all select path, kind, 1, hash from a1 union all select path, kind, 0, hash from a0")
def _(s, d):
    return _tree(X.docs_v1(s, d))


@query("merkle_diff", f"{_V} select concat('d', coalesce(a.doc_id, b.doc_id) % 7, '/e', coalesce(a.doc_id, b.doc_id) % 31, '/', coalesce(a.doc_id, b.doc_id), '.txt') as path, case when a.doc_id is null then 'added' when b.doc_id is null then 'deleted' else 'changed' end as change from docs_v1 a full join docs_v2 b on a.doc_id = b.doc_id where a.doc_id is null or b.doc_id is null or a.text <> b.text")
def _(s, d):
    return M.merkle_diff(durable(_tree(X.docs_v1(s, d))), durable(_tree(X.docs_v2(s, d))))


@query("merkle_visited")
def _(s, d):
    return M.visited_nodes(_tree(X.docs_v1(s, d)), _tree(X.docs_v2(s, d)))


@query("upsert_latest", f"{_V} select doc_id, md5(text) as digest from docs_v2 union all select doc_id, md5(text) from docs_v1 where doc_id not in (select doc_id from docs_v2)")
def _(s, d):
    return S.upsert(X.docs_v1(s, d), X.docs_v2(s, d), ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


@query("cascade_delete", "with gone as (select distinct path from files where contains(path, '/parser/')), g as (select distinct id from symbols where file_path in (select path from gone)) select 'files' as name, count(*) as n from files where path not in (select path from gone) union all select 'symbols', count(*) from symbols where id not in (select id from g) union all select 'chunks', count(*) from chunks where parent_symbol_id not in (select id from g) union all select 'edges', count(*) from edges where coalesce(src, '') not in (select id from g) and coalesce(dst, '') not in (select id from g)")
def _(s, d):
    t = {n: table(s, d, n) for n in ("files", "symbols", "chunks", "edges")}
    gone = t["files"].filter(F.col("path").contains("/parser/")).select("path").distinct()
    out = None
    for n, df in S.cascade_delete(t["files"], t["symbols"], t["chunks"], t["edges"], gone).items():
        c = df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@query("delete_by_tag", "select edge_id from edges where not coalesce(list_contains(tags, 'stack-graphs'), false)")
def _(s, d):
    return S.delete_by_tag(table(s, d, "edges"), "stack-graphs").select("edge_id")


@query("incremental_tokens", rf"{_V} select b.doc_id, cast(ceil(len(regexp_extract_all(b.text, '\S+')) * 13 / 10.0) as bigint) as tokens from docs_v2 b left join docs_v1 a on a.doc_id = b.doc_id where a.doc_id is null or a.text <> b.text")
def _(s, d):
    h = lambda df: df.withColumn("h", F.sha2("text", 256))
    _, out = S.incremental(h(X.docs_v1(s, d)), h(X.docs_v2(s, d)), "doc_id", "h", lambda t: t.select("doc_id", T.count_tokens(F.col("text")).alias("tokens")))
    return out


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
